"""Near-duplicate documents by a join on signature coordinates.

Every set of word shingles gets a signature of minimum hashes. A set is posted under each of its first (coordinate,
value) pairs, in a common order that puts crowded values last; two sets that agree in at least ``matches`` of all
coordinates must meet in one of the first coordinates - matches + 1 (prefix), so the others are never merged but only
looked up to count collisions (skip). Pairs with enough collisions are confirmed on the full sets.

The postings are merged twice. First every member is compared with the first one of its list, which is a row per
posting, and members go to the least first one that they are linked with. Then only lists that hold more than one such
component are merged further: short ones by pairs, crowds in blocks of bounded size, each pair of blocks in a task of
its own that returns the edges of a spanning forest. A crowd of thousands of copies thus costs a comparison each; only
texts that stay apart are compared with all others of their lists.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.graph import components
from vigil.llm.arrow_text import Words, mix, slices, utf8
from vigil.llm.exact_dedup import PAGE_BITS, bit_is_set
from vigil.shared import written

FEW = 32  # members up to which a list is paired
BLOCK = 512  # members of a block, at most about
BLOCK_GRAMS = 1_000_000  # shingles of a block, at most about
COLUMNS = 4096  # shingles that an overlap takes at a time
FAR = np.iinfo(np.uint64).max


def match_threshold(coordinates: int, similarity: float, miss: float) -> int:
    """The most collisions to ask for so that a pair at the similarity falls below by a chance of at most ``miss``."""
    below = 0.0
    for k in range(coordinates + 1):
        below += comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below > miss:
            return max(k, 1)
    return coordinates


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, A-Z lower-cased; fewer words are one shingle, no word gives none."""
    data, offsets = utf8(column)
    words = Words(np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8), offsets)
    grams = words.windows(size)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if 0 < b - a < size:
            at = np.arange(b - a, dtype=np.uint64)
            out.append(mix(np.bitwise_xor.reduce(mix(words.hashes[a:b] + at), keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.unique(grams[a:max(b - size + 1, a)]))
    return out


def signatures(docs: DataFrame, coordinates: int, size: int) -> DataFrame:
    """(row, id, text_hash, set: hash of the shingle set or null, n, signature) from (row, id, text_hash, text)."""
    rng = np.random.default_rng(12)
    a = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets, counts, signed = [], [], []
                for x in shingle_sets(batch.column("text"), size):
                    counts.append(len(x))
                    least = np.full(coordinates, FAR, np.uint64)
                    for at in range(0, len(x), 2048):
                        np.minimum(least, (x[at:at + 2048, None] * a + b).min(axis=0), out=least)
                    order = np.arange(1, len(x) + 1, dtype=np.uint64)
                    both = ((mix(x) * order).sum(), np.bitwise_xor.reduce(mix(x + np.uint64(1))))
                    sets.append(b"".join(int(v).to_bytes(8, "big") for v in both) if len(x) else None)
                    signed.append(least.view(np.int64) if len(x) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), batch.column("id"), batch.column("text_hash"), pa.array(sets, pa.binary()),
                        pa.array(counts, pa.int64()), pa.array(signed, pa.list_(pa.int64())),
                    ],
                    names=["row", "id", "text_hash", "set", "n", "signature"],
                )

    return docs.mapInArrow(run, "row long, id long, text_hash long, set binary, n long, signature array<long>")


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, grams) from (node, text)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [x.view(np.int64) for x in shingle_sets(batch.column("text"), size)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "grams"])

    return texts.mapInArrow(run, "node long, grams array<long>")


def prefixes(classes: DataFrame, length: int) -> DataFrame:
    """(node, n, list): each signature's first coordinates in the order of how many share their value.

    The order is the same for all signatures: values that at most ``FEW`` share by coordinate, then the others by number.
    A shingle that many otherwise different texts hold, and that is the least of a coordinate, so comes last.
    """
    lists = F.transform("signature", lambda value, at: F.struct(at.cast("int").alias("at"), F.xxhash64(at, value).alias("list")))
    keys = classes.select("node", "n", lists.alias("lists"))
    single = keys.select("node", F.explode("lists").alias("key")).select("node", "key.at", "key.list")
    crowded = written(single.groupBy("list").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > FEW), "crowded")
    number = F.map_from_entries(F.collect_list(F.struct("at", "members")))
    numbers = written(single.join(crowded, "list").groupBy("node").agg(number.alias("numbers")), "numbers")
    joined = keys.join(numbers, "node", "left")
    ranked = F.transform("lists", lambda x: F.struct(
        F.coalesce(F.try_element_at("numbers", x["at"]), F.lit(0).cast("long")).alias("members"), x["at"].alias("at"), x["list"].alias("list")
    ))
    first = F.slice(F.when(F.col("numbers").isNull(), ranked).otherwise(F.array_sort(ranked)), 1, length)
    return joined.select("node", "n", F.explode(first).alias("key")).select("node", "n", "key.list")


def _long_enough(percent: int, a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def colliding(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough coordinates."""
    left = classes.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"))
    right = classes.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"))
    collisions = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    return written(pairs.join(right, "b").join(left, "a").filter(collisions >= matches).select("a", "b"), "candidates")


def confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    both = near.join(right, "b").join(left, "a").withColumn("both", F.size(F.array_intersect("grams_a", "grams_b")).cast("long"))
    return both.filter(100 * F.col("both") >= percent * (F.size("grams_a") + F.size("grams_b") - F.col("both"))).select("a", "b")


def sets_of(source: DataFrame, classes: DataFrame, nodes: DataFrame, size: int, max_bits: int = 1 << 27) -> DataFrame:
    """(node, grams) of some nodes, from the texts of ``source``.

    Rows of other texts are dropped before the shuffle by a bitmap, which never has more than ``max_bits`` bits; what it
    lets through by chance, the join drops.
    """
    needed = classes.join(nodes.distinct().withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    needed = written(needed.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "node"), "needed")
    pages = min(max_bits // PAGE_BITS, needed.count() * 16 // PAGE_BITS + 1)
    at = F.pmod(F.xxhash64("_id", "_hash"), F.lit(pages * PAGE_BITS))
    bitmap = needed.select(at.alias("at")).groupBy((F.col("at") / PAGE_BITS).cast("long").alias("page"))
    bitmap = bitmap.agg(F.bitmap_construct_agg(F.col("at") % PAGE_BITS).alias("bitmap"))
    rows = source.withColumn("at", F.pmod(F.xxhash64("id", "text_hash"), F.lit(pages * PAGE_BITS)))
    likely = rows.join(F.broadcast(bitmap), (F.col("at") / PAGE_BITS).cast("long") == F.col("page")).filter(
        bit_is_set(F.col("bitmap"), F.col("at") % PAGE_BITS)
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    texts = likely.select("id", "text_hash", "text").join(needed, same).select("node", "text")
    return written(full_sets(texts, size).dropDuplicates(["node"]), "sets")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, as a matrix."""
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    common = count > 1
    place = (np.cumsum(common) - 1)[code]
    owner, place = owner[common[code]], place[common[code]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(common.sum()), COLUMNS):
        lo, hi = np.searchsorted(place, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[lo:hi], place[lo:hi] - at] = 1
        out += part @ part.T
    return out


def spanning_links(rows: pd.DataFrame, matches: int, percent: int) -> pd.DataFrame:
    """Links between two blocks (or inside one) that connect all components which links between them connect."""
    rows = rows.sort_values(["own", "node"]).reset_index(drop=True)
    own, n = rows["own"].to_numpy(), rows["n"].to_numpy()
    _, label = np.unique(rows["component"].to_numpy(), return_inverse=True)
    signed = np.stack(rows["signature"].to_numpy())
    collisions = np.zeros((len(rows), len(rows)), np.uint16)
    for k in range(signed.shape[1]):
        collisions += signed[:, k][:, None] == signed[:, k][None, :]
    near = (collisions >= matches) & (label[:, None] != label[None, :])
    near &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    if own[0] != own[-1]:
        near &= own[:, None] != own[None, :]
    used = np.flatnonzero(near.any(axis=1))
    out = []
    if len(used):
        both = overlaps([rows["grams"][i] for i in used]).astype(np.int64)
        linked = near[np.ix_(used, used)] & (100 * both >= percent * (n[used][:, None] + n[used][None, :] - both))
        parent = list(range(label.max() + 1))

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, j in np.argwhere(np.triu(linked)):
            a, b = root(label[used[i]]), root(label[used[j]])
            if a != b:
                parent[a] = b
                out.append((rows["component"][used[i]], rows["component"][used[j]]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def crowd_links(crowds: DataFrame, classes: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links (a, b) between components of crowded lists (list, members, node, n, component).

    A member's home is its largest list. Homes are cut into blocks, and two blocks are compared if a list spans both.
    """
    home = crowds.groupBy("node").agg(F.max(F.struct("members", "list")).alias("home"), F.min("n").alias("n"), F.min("component").alias("component"))
    home = written(home.select("node", "n", "component", F.col("home.list").alias("home")), "homes")
    blocks = home.groupBy("home").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks")
    )
    own = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("blocks")))
    home = written(home.join(blocks, "home").select("node", "n", "component", own.alias("own")), "blocks")
    touched = written(crowds.select("list", "node").join(home.select("node", "own"), "node").select("list", "own").distinct(), "touched")
    pairs = touched.join(touched.select("list", F.col("own").alias("other")), "list").filter("own <= other").select("own", "other").distinct()
    pairs = written(pairs.withColumn("pair", F.xxhash64("own", "other")), "block-pairs")
    dealt = pairs.select("pair", "own").unionByName(pairs.select("pair", F.col("other").alias("own"))).distinct()
    filled = home.join(classes.select("node", "signature"), "node").join(sets, "node").join(dealt, "own")
    return filled.groupBy("pair").applyInPandas(lambda rows: spanning_links(rows, matches, percent), "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of all classes, where nodes of one component are surely connected, but not yet all that are.

    From links (a, b) of first members a: a node goes to the least of its firsts, and on to that one's.
    """
    low = links.groupBy("b").agg(F.min("a").alias("low"))
    next_low = low.select(F.col("b").alias("_b"), F.col("low").alias("_low"))
    label = low.join(next_low, F.col("low") == F.col("_b"), "left").select("b", F.coalesce("_low", "low").alias("label"))
    return classes.join(label, F.col("node") == F.col("b"), "left").select("node", F.coalesce("label", "node").alias("component"))


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links (a, b) between components."""
    more = components(links).select(F.col("id").alias("component"), F.col("component").alias("least"))
    return written(parts.join(more, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "parts")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85, coordinates: int = 64,
    miss: float = 1e-5,
) -> tuple[DataFrame, DataFrame]:
    """(row, id, text_hash, set, n), one per row, and (set, n, node, id, component) of the distinct shingle sets.

    component is the least node that confirmed links connect a set to. A pair at exactly the similarity is missed by a
    chance of at most ``miss``; sets that are equal are one.
    """
    matches = match_threshold(coordinates, percent / 100, miss)
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    marked = written(signatures(source.withColumn("row", F.monotonically_increasing_id()), coordinates, size), "signatures")
    classes = marked.filter("set is not null").groupBy("set", "n").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "row", "text_hash")).alias("least"), F.min("signature").alias("signature")
    )
    classes = written(classes.select("set", "n", "signature", F.col("least.row").alias("node"), "least.id", "least.text_hash"), "classes")
    posted = written(prefixes(classes, coordinates - matches + 1), "postings")
    shared = posted.groupBy("list").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("node", "n")).alias("first")).filter("members > 1")
    lists = written(posted.join(written(shared, "shared"), "list"), "lists")

    star = lists.filter((F.col("node") != F.col("first.node")) & _long_enough(percent, F.col("n"), F.col("first.n")))
    star = star.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    near = colliding(star, classes, matches)
    sets = sets_of(source, classes, _ends(near), size)
    links = written(confirmed(near, sets, percent), "star-links")
    parts = written(_labelled(classes, links), "parts")
    left, right = (parts.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}")) for x in "ab")
    joints = links.join(left, "a").join(right, "b").filter("part_a != part_b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))

    placed = lists.select("list", "members", "node", "n").join(parts, "node")
    several = placed.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("list")
    open_lists = written(placed.join(several, "list"), "open")
    few = open_lists.filter(F.col("members") <= FEW)
    left = few.select("list", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("part_a"))
    right = few.select("list", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("part_b"))
    apart = (F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & _long_enough(percent, F.col("n_a"), F.col("n_b"))
    pairs = written(left.join(right, "list").filter(apart).select("a", "b", "part_a", "part_b").distinct(), "pairs")
    crowds = open_lists.filter(F.col("members") > FEW)
    near = colliding(pairs.select("a", "b"), classes, matches)
    sets = sets_of(source, classes, _ends(near).unionByName(crowds.select("node")), size)
    found = confirmed(near, sets, percent).join(pairs, ["a", "b"])
    links = joints.unionByName(found.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
    if not crowds.isEmpty():
        links = links.unionByName(crowd_links(crowds, classes, sets, matches, percent))
    links = written(links.distinct(), "links")
    if not links.isEmpty():
        parts = _joined(parts, links)
    named = parts.withColumnRenamed("node", "_node")
    return marked, written(classes.join(named, F.col("node") == F.col("_node")).select("set", "n", "node", "id", "component"), "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_shingles (distinct), component_id (smallest id reachable by links), kept (that id is its own).

    Two texts are linked if their sets of ``size``-word shingles meet the similarity; a text of fewer words is one
    shingle. Null and empty texts, and those of spaces only, have no shingle and stand alone. Rows without an id take
    part and are never kept; a component of such rows only has no id. Repeated rows are copies of each other; those of
    the least id are all kept. Other columns are not returned.
    """
    marked, classes = near_classes(docs, id_col, text_col, **options)
    least = classes.groupBy("component").agg(F.min("id").alias("component_id")).withColumnRenamed("component", "_component")
    named = written(classes.join(least, F.col("component") == F.col("_component")).select("set", "n", "component_id"), "component-ids")
    out = marked.select("id", "set", "n").join(named, ["set", "n"], "left")
    component = F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))
    )
