"""Prefix trie of conversations by vertical bitmaps.

The turns of all conversations, in the order of id and position, are cut into shards of a bounded number of rows. A
shard numbers its conversations, posts each (position, turn) to a bitset of them, and walks the trie depth first: the
parent's bitset intersected with a posting gives a child, its population count the members in this shard, and the
intersection with the conversations that end at a position the list of ends. A node's identity is a hash of its path
that adds up over turns (exclusive or, 128 bits), so a conversation may be cut between shards, and nodes of different
shards are joined by it. A conversation, a first turn or a path with a third of all rows is a row per shard and node.

Subtrees are summed in rounds of doubled distance: in each round a node adds up what the nodes at that distance below
it have gathered so far, so that the rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.ordered import running_sum
from vigil.shared import written

SHARD_BITS = 14  # a shard has at most 2 to this number of rows
KEY = ["p1", "p2", "depth"]
SWITCH, MOST = 5, 9  # fixed values of the output contract: conversations of a family, and turns they share, below this


def ordered_turns(conversations: DataFrame, id_col: str) -> DataFrame:
    """(conv, rank, code, bytes): the turns of each conversation by number from 0, the turn as a hash, the bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.filter("conv is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    code = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    numbered = rows.select(
        "conv", code.alias("code"), F.octet_length("text").cast("long").alias("bytes"), F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("seq"), F.lit(1).cast("long").alias("one"),
    )
    return running_sum(written(numbered, "turns"), ["conv"], "part", [F.col("seq")], "one", "start", "rank").select("conv", "rank", "code", "bytes")


def rebuilt(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv, depth, code, bytes, last): every conversation with the stated number of first turns taken from the first of its family.

    Depth 0 is the root, which every conversation has; last marks a conversation's final row.
    """
    ranked = written(ordered_turns(conversations, id_col), "ranked")
    sizes = written(ranked.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "sizes")
    plan = sizes.withColumns({
        "family": F.col("conv") - F.col("conv") % SWITCH, "shared": F.crc32(F.col("conv").cast("string").cast("binary")) % MOST,
    })
    first = sizes.select(F.col("conv").alias("family"), F.col("n").alias("n_first"))
    taken = F.least("shared", F.coalesce("n_first", F.lit(0)))
    plan = plan.join(first, "family", "left").withColumn("taken", taken)
    plan = written(plan.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))), "plan")
    own = ranked.join(plan, "conv").filter(F.col("rank") >= F.col("shared"))
    own = own.select("conv", (F.col("rank") - F.col("shared") + F.col("taken") + 1).alias("depth"), "code", "bytes", "length")
    heads = ranked.filter(F.col("rank") < MOST).select(F.col("conv").alias("family"), "rank", "code", "bytes")
    heads = heads.join(plan, "family").filter(F.col("rank") < F.col("shared"))
    heads = heads.select("conv", (F.col("rank") + 1).alias("depth"), "code", "bytes", "length")
    roots = plan.select("conv", F.lit(0).cast("long").alias("depth"), F.lit("").alias("code"), F.lit(0).cast("long").alias("bytes"), "length")
    return own.unionByName(heads).unionByName(roots).withColumn("last", F.col("depth") == F.col("length")).drop("length")


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def shard_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes that the conversations of one shard pass, with their members and ends in this shard."""
    rows = rows.sort_values("seq")
    conv, depth, code = rows["conv"].tolist(), rows["depth"].tolist(), rows["code"].tolist()
    hashed = list(zip(rows["x1"].tolist(), rows["x2"].tolist(), rows["bytes"].tolist(), strict=True))
    shard = int(rows["shard"].iloc[0])
    ids: list[int] = []
    posting: dict[tuple[int, str], int] = defaultdict(int)
    turn: dict[tuple[int, str], tuple[int, int, int]] = {}
    position: dict[int, int] = defaultdict(int)
    ended: dict[int, int] = defaultdict(int)
    said: dict[tuple[int, int], str] = {}
    for c, d, k, x, last in zip(conv, depth, code, hashed, rows["last"].tolist(), strict=True):
        if not ids or ids[-1] != c:
            ids.append(c)
        member = 1 << (len(ids) - 1)
        posting[d, k] |= member
        position[d] |= member
        turn[d, k] = x
        said[len(ids) - 1, d] = k
        if last:
            ended[d] |= member
    fresh = position[0]
    stack = [(-1, 0, 0, fresh)]
    if not fresh & 1:  # the first conversation has begun in an earlier shard
        stack.append((depth[0] - 1, int(rows["start1"].iloc[0]), int(rows["start2"].iloc[0]), 1))
    out = []
    while stack:
        at, p1, p2, members = stack.pop()
        rest = members & position.get(at + 1, 0)
        while rest:
            i = (rest & -rest).bit_length() - 1
            key = (at + 1, said[i, at + 1])
            child = members & posting[key]
            rest &= ~child
            x1, x2, size = turn[key]
            ends = child & ended.get(at + 1, 0)
            out.append((
                p1 ^ x1, p2 ^ x2, at + 1, p1, p2, shard, child.bit_count(), ids[i], size, ",".join(str(ids[j]) for j in _bits(ends)) if ends else None,
            ))
            stack.append((at + 1, p1 ^ x1, p2 ^ x2, child))
    return pd.DataFrame(out, columns=["p1", "p2", "depth", "q1", "q2", "shard", "n", "conv", "bytes", "ends"])


def shards(items: DataFrame) -> DataFrame:
    """The nodes by shard of (conv, depth, code, bytes, last)."""
    spread = items.repartitionByRange("conv", "depth").sortWithinPartitions("conv", "depth")
    zero = F.lit(0).cast("long")
    spread = spread.select(
        "*", F.when(F.col("depth") == 0, zero).otherwise(F.xxhash64("depth", "code")).alias("x1"),
        F.when(F.col("depth") == 0, zero).otherwise(F.xxhash64("code", F.lit(13), "depth")).alias("x2"),
        F.monotonically_increasing_id().alias("seq"),
    )
    spread = written(spread.withColumn("shard", F.shiftright("seq", SHARD_BITS)), "items")
    before = Window.partitionBy("conv").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begun = spread.groupBy("conv", "shard").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.min("depth").alias("from"))
    begun = begun.select(
        "shard", "from", F.bit_xor("x1").over(before).alias("start1"), F.bit_xor("x2").over(before).alias("start2")
    ).filter("`from` > 0").drop("from")
    rows = spread.join(begun, "shard", "left")
    spec = "p1 long, p2 long, depth long, q1 long, q2 long, shard long, n long, conv long, bytes long, ends string"
    return written(rows.groupBy("shard").applyInPandas(shard_nodes, spec), "shard-nodes")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p1, p2, depth, hash) of the lists of each node, joined by commas, as they come."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    names, held = [*KEY, "ends_sha256"], []
    for key, group in groupby(rows, key=lambda r: r[:3]):
        digest, first = hashlib.sha256(), True
        for *_, ends in group:
            digest.update((ends if first else "," + ends).encode())
            first = False
        held.append((*key, digest.hexdigest()))
        if len(held) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=names)


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(p1, p2, depth, values): sums over the subtree of each node (p1, p2, depth, q1, q2: the parent's hash, values)."""
    active = nodes.select(*KEY, F.col("q1").alias("j1"), F.col("q2").alias("j2"), *values)
    parts = [active.select(*KEY, *values)]
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step <= deepest:
        given = active.filter(F.col("depth") >= step).groupBy(
            F.col("j1").alias("p1"), F.col("j2").alias("p2"), (F.col("depth") - step).alias("depth")
        ).agg(*[F.sum(v).alias(v) for v in values])
        given = written(given, "given")
        parts.append(given)
        if 2 * step <= deepest:
            over = active.filter(F.col("depth") >= step).select(
                F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("depth").alias("a"), F.col("j1").alias("b1"), F.col("j2").alias("b2")
            )
            deep = active.filter(F.col("depth") >= 2 * step)
            deep = deep.join(over, (F.col("j1") == F.col("a1")) & (F.col("j2") == F.col("a2")) & (F.col("depth") - step == F.col("a")))
            more = given.select(*KEY, *[F.col(v).alias(f"more_{v}") for v in values])
            deep = deep.join(more, KEY, "left")
            active = written(deep.select(
                *KEY, F.col("b1").alias("j1"), F.col("b2").alias("j2"), *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]
            ), "active")
        step *= 2
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in values])


def trie(items: DataFrame) -> DataFrame:
    """One row per node of the trie over (conv, depth, code, bytes, last); see ``conversation_trie``."""
    found = shards(items)
    nodes = found.groupBy(*KEY).agg(
        F.sum("n").alias("n_convs"), F.min("conv").alias("conv"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.max("bytes").alias("bytes")
    )
    nodes = written(nodes, "nodes")
    above = [F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("depth")]
    children = nodes.filter("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    own = nodes.join(children, KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes"),
        "leaf": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
    })
    own = written(own, "trie")
    sums = subtree_sums(own, ["leaf", "saved"]).toDF(*KEY, "n_leaves", "saved_tokens")
    ends = found.filter("ends is not null").select(*KEY, "shard", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "shard")
    hashes = ends.select(*KEY, "ends").mapInArrow(_hashes, "p1 long, p2 long, depth long, ends_sha256 string")
    parent = nodes.select(
        F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv_id")
    )
    out = own.join(sums, KEY).join(hashes, KEY, "left").join(parent, ["q1", "q2", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The trie of the rebuilt conversations: one row per distinct sequence of first turns, the empty one included.

    conv_id is the least conversation that begins with the sequence, n_convs their number, n_leaves the childless nodes
    below (itself if it is one), saved_tokens the bytes of text that need not be stored again in the subtree, ends_sha256
    a hash of the ids that end here. Turns go by number, null first, then role and text; null roles and texts are empty.
    Rows without a conversation id belong to none and are left out; repeated rows are turns of their own. Other columns
    are not returned. Without any conversation there is no node.
    """
    return trie(rebuilt(conversations, id_col))


def trie_of(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The same trie over the conversations as they are."""
    ranked = written(ordered_turns(conversations, id_col), "ranked")
    sizes = ranked.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    roots = sizes.select("conv", zero.alias("depth"), F.lit("").alias("code"), zero.alias("bytes"), F.lit(False).alias("last"))
    turns = ranked.join(sizes, "conv").select(
        "conv", (F.col("rank") + 1).alias("depth"), "code", "bytes", (F.col("rank") + 1 == F.col("n")).alias("last")
    )
    return trie(turns.unionByName(roots))
